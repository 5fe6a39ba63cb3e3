"""Marlstone: retrieval, conversation and corpus analytics expressed as Spark jobs."""
