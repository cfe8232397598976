"""matchloom.operators"""
