"""scanloom: a PySpark engine for catalogues of scanned documents and their page images."""
