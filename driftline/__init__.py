"""Spark operators over detector traces, point clouds, labels and pad maps."""
