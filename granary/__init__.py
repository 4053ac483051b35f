"""DataFrame operators and plans for program and grant analytics on Spark."""
