"""dayline.streaming"""
