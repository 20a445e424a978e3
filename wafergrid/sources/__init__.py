"""wafergrid.sources"""
