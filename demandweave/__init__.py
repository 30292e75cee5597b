"""demandweave: skill-demand analytics over job postings, written as Spark DataFrame jobs."""
