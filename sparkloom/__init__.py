"""sparkloom: a Spark-first engine for source trees, histories, call graphs and vectors."""
