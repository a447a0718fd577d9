"""Training-data operators for very large document tables.

Nothing outside this subpackage imports it, so that it can be removed as a whole."""
