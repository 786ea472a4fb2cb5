"""papyra.export"""
