"""Spark-native log dataflow engine: sources, line operators, span algebra, usage report and sinks."""
