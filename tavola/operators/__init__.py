"""tavola.operators"""
