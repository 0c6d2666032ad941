"""Document-layout analytics on Spark: lines, paragraphs, tables, images and outlines as DataFrames."""
