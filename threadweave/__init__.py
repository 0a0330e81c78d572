"""Conversation-graph and corpus analytics as Spark DataFrame programs."""
