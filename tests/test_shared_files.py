import threading

from curbwatch.session import shared_dir
from curbwatch.sources.shared_files import SharedFiles


def test_create_read_replace_delete(spark):
    files, root = SharedFiles(spark), shared_dir(spark, "test_files")
    assert files.names(root) == [] and files.read(f"{root}/a") is None and not files.exists(f"{root}/a")
    assert files.create(f"{root}/a", "één") is True
    assert files.create(f"{root}/a", "two") is False
    assert files.read(f"{root}/a") == "één"
    files.replace(f"{root}/a", "three")
    files.replace(f"{root}/b/c", "new")
    assert (files.read(f"{root}/a"), files.read(f"{root}/b/c")) == ("three", "new")
    assert files.names(root) == ["a", "b"] and files.size(root) == 8
    assert files.delete(f"{root}/b") is True and files.delete(f"{root}/b") is False
    assert files.names(root) == ["a"]


def test_a_reader_never_sees_half_a_file(spark):
    files, path = SharedFiles(spark), shared_dir(spark, "test_swap") + "/current"
    texts = ["x" * 40_000, "y" * 40_000]
    files.replace(path, texts[0])
    seen, done = [], threading.Event()

    def read():
        while not done.is_set():
            seen.append(SharedFiles(spark).read(path))

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(60):
        files.replace(path, texts[i % 2])
    done.set()
    reader.join()
    assert seen and set(seen) <= set(texts)
