"""matchloom.functions"""
