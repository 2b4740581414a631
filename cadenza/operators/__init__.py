"""DataFrame-to-DataFrame operators, meant to be chained with ``transform``."""
