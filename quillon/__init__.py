"""quillon: batch passage retrieval and document analytics as Spark DataFrame plans."""
