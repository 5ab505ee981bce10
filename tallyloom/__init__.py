"""tallyloom: session analytics on Spark, from transcripts to scored, priced and redacted reports."""
