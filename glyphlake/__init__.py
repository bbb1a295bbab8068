"""Document analytics on Spark: segmentation, vector search, registries and attribute extraction as DataFrame plans."""
