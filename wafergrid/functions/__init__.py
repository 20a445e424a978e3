"""wafergrid.functions"""
