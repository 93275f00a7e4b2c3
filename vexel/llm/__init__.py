"""Training-data operators: search, joins, archives, filters, scans, packing, placement and mixing.

Nothing else in the library imports this subpackage.
"""
