"""loomwork: topic-focused web-graph analytics as DataFrame operators on Spark."""
