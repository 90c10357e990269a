"""certloom: certificate-stream threat analytics and corpus preparation on Spark."""
