"""DataFrame -> DataFrame operators of the analysis layers."""
