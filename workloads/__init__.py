"""Graphs made from the driver's tables, and the registered queries over them."""
