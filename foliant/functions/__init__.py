"""Byte-level kernels without Spark: values, files, filters, page contents, chunking, binary rows."""
