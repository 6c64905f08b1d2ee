"""Conversation-timeline analytics on Spark DataFrames."""
