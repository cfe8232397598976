"""matchloom.plans"""
