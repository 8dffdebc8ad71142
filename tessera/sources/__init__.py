"""Readers and writers for the tables and JSONL files the jobs exchange."""
