"""Analytics over small computation graphs and the record sets that flow through them, on Spark."""
