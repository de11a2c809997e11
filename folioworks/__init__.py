"""folioworks: document-image and text-recognition analytics on Spark DataFrames."""
