"""factloom: evidence-aware memory analytics and corpus preparation as Spark plans."""
