"""factloom.plans"""
