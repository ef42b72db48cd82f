"""The registered queries: plans of the package over the test tables."""
