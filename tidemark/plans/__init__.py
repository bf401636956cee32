"""Query plans: the fluent stream facade and the registered queries with their SQL."""
