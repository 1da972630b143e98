"""veilspan: set-at-a-time text governance analytics on PySpark."""
