"""tavola.sources"""
