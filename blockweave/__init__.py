"""Analytics over content-addressed chunks."""
