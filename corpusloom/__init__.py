"""corpusloom: text-corpus ETL, ranked retrieval and answer scoring as Spark DataFrame plans."""
