"""chronika: event-catalogue analytics, cleansing and entity resolution on Spark DataFrames."""
