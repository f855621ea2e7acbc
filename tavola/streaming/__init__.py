"""tavola.streaming"""
