"""Training-data operators: ten corpus-scale steps over documents and pages."""
