"""Polling state as streams of snapshots."""
