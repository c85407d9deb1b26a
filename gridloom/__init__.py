"""Sparse-matrix analytics on Spark DataFrames: QC, normalisation, feature selection, PCA, clustering, validation."""
