"""Column functions: text and identifier normalisation, segmentation, JSON, similarity."""
