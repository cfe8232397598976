"""matchloom.sources"""
