"""Set-oriented reduction and analysis of machine-generated text on Spark."""
