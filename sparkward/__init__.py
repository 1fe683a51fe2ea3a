"""Governed analytics on Spark: scoped views, masking, bounded results, reviewed
mutations, audit analytics and windowed enforcement as DataFrame jobs."""
