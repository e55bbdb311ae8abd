"""strandlake: coloured k-mer graph analytics and corpus preparation on PySpark."""
