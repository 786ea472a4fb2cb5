"""papyra.sources"""
