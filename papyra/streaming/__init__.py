"""papyra.streaming"""
