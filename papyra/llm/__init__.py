"""Training-data operators for large text corpora. Nothing else in papyra imports this."""
