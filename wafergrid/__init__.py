"""wafergrid: few-shot anomaly scoring and segmentation evaluation on Spark DataFrames."""
