"""papyra.plans"""
