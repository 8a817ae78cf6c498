"""Run-log analytics on Spark: silver tables of steps, parts and tool calls, and the questions asked of them."""
