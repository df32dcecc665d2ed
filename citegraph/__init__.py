"""Science mapping on Spark: paper networks, communities, words, topics and impact."""
