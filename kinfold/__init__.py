"""kinfold: a PySpark-native customer-data engine.

Change events are checked, deduplicated, resolved into customers, modelled into
marts and histories, gated by consent, exported and reconciled - all as
DataFrame plans that Catalyst optimises.
"""

__version__ = "0.1.0"
