"""Transit-accessibility analytics as composable Spark DataFrame functions."""
