"""Analytics over labelled network-flow logs, as composable Spark DataFrame operators."""
