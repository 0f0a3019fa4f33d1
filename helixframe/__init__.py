"""Structure and motif analytics as Spark DataFrame operators."""
