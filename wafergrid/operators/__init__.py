"""wafergrid.operators"""
