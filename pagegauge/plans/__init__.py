"""End-to-end jobs assembled from sources and operators."""
