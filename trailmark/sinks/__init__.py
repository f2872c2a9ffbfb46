"""Writers of graphs and captures."""
