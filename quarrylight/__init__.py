"""Security analytics over collections of source code and text, as Spark DataFrames."""
