"""quillspark.operators"""
