"""postcheck: campaign reconciliation and efficiency analytics as composable Spark DataFrame operators."""
