"""Training-data operators: the only subpackage that other code never imports."""
