"""Reports, automatic reports and questions, each resolving to DataFrames."""
