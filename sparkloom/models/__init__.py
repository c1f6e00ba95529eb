"""Models that are fitted by passes over all rows: penalised and quantile regression, clusters, components, trees, likelihoods."""
