"""Invoice data processing, and operators for large text corpora, as PySpark DataFrame transformations."""
