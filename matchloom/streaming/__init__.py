"""matchloom.streaming"""
