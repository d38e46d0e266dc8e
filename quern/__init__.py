"""quern: video-retrieval, routing and frame-analysis operators as Spark DataFrame plans."""
