"""topicweave: topic-signal analytics and text-corpus operators on Spark DataFrames."""
