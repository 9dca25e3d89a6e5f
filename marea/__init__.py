"""Causal analytics over keyed event-time streams, as Spark DataFrame jobs."""
