"""factloom: code-fact analytics (sets, cohesion, clones, dependences, clusters) as Spark DataFrame operators."""
