"""wafergrid.streaming"""
