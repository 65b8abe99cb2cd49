"""runlens: run telemetry, verification evidence and corpus operators on PySpark."""
