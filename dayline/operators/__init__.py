"""dayline.operators"""
