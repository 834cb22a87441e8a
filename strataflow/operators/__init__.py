"""DataFrame operators: temporal views and joins, graph algorithms, search, memory and ontology."""
