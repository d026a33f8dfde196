"""DataFrame operators, one module per section of the inventory."""
