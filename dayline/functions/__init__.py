"""dayline.functions"""
