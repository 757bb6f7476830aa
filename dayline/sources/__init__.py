"""dayline.sources"""
