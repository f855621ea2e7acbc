"""tavola.functions"""
